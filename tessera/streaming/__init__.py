"""Nothing here: scans and builds are one-shot, so there is no streaming operator to offer.

The operators take any batch DataFrame; those without a window over the whole
input (classification, projections, manifest parsing) also take streaming ones.
"""
