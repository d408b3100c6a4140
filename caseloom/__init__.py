"""caseloom: bulk triage of operations tickets on Spark."""
