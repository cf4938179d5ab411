"""carrierlab: carrier and penetrance analytics as Spark DataFrame plans."""
