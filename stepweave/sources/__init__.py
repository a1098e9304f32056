"""stepweave sources"""
