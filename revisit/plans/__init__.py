"""Jobs assembled from the operators: features, training, scoring, flagging."""
