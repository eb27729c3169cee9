"""How plans are cut, spread and addressed: lineage cuts, column picking, skew."""
