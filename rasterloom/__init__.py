"""Time-windowed compositing of multi-band observations, and the operators around it, as Spark DataFrame plans."""
