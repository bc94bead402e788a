"""plumbgrid.sources"""
