"""plumbgrid.sinks"""
