"""strandline.sources"""
