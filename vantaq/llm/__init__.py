"""Training-data operators: ten building blocks for cleaning, joining and packing text corpora."""
