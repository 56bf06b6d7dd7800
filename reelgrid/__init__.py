"""reelgrid: media-measurement analytics expressed as Spark DataFrame plans."""
