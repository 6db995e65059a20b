"""Record linkage on Spark DataFrames: noisy observations to the entries of a catalogue."""
