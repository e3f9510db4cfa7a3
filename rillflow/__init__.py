"""Declarative keyed streams on Spark: map, reduce, join and window over keyed, append-only logs, and data-processing operators beside them."""
