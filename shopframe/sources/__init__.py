"""shopframe.sources"""
