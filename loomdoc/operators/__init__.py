"""loomdoc.operators"""
