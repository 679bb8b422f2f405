"""emberline.sources"""
