"""heddle.streaming"""
