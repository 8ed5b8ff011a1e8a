"""heddle.operators"""
