"""Report structuring on Spark: roll-up, form parsing, labelling, training and evaluation."""
