"""loomdoc.plans"""
