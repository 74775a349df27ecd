"""Market-data event archives, state-at-tick and audits as Spark DataFrame operators."""
