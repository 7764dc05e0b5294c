"""loomdoc.sources"""
