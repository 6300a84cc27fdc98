"""Field analytics on Spark: frames, masks, matching and kinematics as DataFrames."""
