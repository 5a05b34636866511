"""strandline.plans"""
