"""plumbgrid.operators"""
