"""panelwright: entity-period panel analytics as Spark DataFrame jobs."""
