"""plumbgrid.plans"""
