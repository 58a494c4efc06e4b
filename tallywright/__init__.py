"""tallywright: results and analysis tables of contributed game playing, as Spark jobs."""
