"""strandline.streaming"""
