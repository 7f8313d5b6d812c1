"""No streaming: all inputs are bounded tables, and no operator keeps state over time. Resumable
batch runs are worklists (see ``waymark.operators.relational.difference``)."""
