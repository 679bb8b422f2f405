"""emberline.streaming"""
