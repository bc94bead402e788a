"""plumbgrid.functions"""
