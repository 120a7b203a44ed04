"""Seeded random fields: coordinates, expansions, kriging and conditional draws.

Each sample has a generator of its own, from the seed and the sample's id, so
draws don't depend on partitions. Dense algebra of the few observations or
modes runs once on the driver; samples and cells are done in Arrow batches.
"""
