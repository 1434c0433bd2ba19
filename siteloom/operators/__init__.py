"""siteloom.operators"""
