"""factlens.sources"""
