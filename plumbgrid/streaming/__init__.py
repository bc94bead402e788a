"""plumbgrid.streaming"""
