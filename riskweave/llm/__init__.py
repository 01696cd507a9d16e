"""Training-data operators: ten steps between raw documents and packed, sharded token files."""
