"""shopframe.functions"""
