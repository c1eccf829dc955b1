"""shopframe.operators"""
