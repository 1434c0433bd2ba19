"""siteloom.sources"""
