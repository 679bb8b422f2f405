"""emberline.operators"""
