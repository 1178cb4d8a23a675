"""palmleaf: document analytics as declarative Spark plans."""
