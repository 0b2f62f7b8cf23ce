"""Folders of the driver's tables that the tests read."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
