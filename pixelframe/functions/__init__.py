"""Column functions, container walkers and pixel codecs."""
