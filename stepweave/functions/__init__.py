"""stepweave functions"""
