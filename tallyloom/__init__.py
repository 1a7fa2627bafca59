"""tallyloom: conversational order analytics as Spark DataFrame pipelines."""
