"""stepweave operators"""
