"""shopframe.plans"""
