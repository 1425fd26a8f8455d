"""Evidence assembly from clinical and claims tables, as Spark DataFrame operators."""
