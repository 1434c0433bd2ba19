"""siteloom.streaming"""
