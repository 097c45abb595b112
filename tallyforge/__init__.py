"""tallyforge: evaluation analytics and corpus operators as Spark plans."""
