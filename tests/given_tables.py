"""The folder of the smallest given tables."""
SF001 = "/root/testdata/sf0.001"
