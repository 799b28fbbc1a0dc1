"""contigbin: contig binning and its surrounding data processing as Spark plans."""

__version__ = "0.1.0"
