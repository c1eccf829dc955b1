"""shopframe.streaming"""
