"""Record linkage over material master data, procurement analytics and training-data operators, on Spark."""
