"""emberline.plans"""
