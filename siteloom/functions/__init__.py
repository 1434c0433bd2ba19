"""siteloom.functions"""
