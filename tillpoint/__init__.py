"""tillpoint: the reports and data jobs of a point-of-sale shop as PySpark
"""
