"""siteloom.plans"""
