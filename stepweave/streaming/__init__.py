"""stepweave streaming"""
