"""Sources and sinks: FASTA, GFA, walks, alignments, coverage, registries, assignments."""
