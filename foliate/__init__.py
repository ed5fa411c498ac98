"""Record linkage and catalog curation on Spark."""
