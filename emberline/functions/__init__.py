"""emberline.functions"""
