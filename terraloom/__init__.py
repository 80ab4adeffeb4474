"""Spark-native geospatial transfer and parcel analytics."""
