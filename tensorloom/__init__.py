"""tensorloom: sparse-tensor factorisation and data-processing operators on PySpark."""
