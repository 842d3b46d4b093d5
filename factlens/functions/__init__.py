"""factlens.functions"""
