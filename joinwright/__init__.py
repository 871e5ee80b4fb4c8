"""joinwright: a PySpark-native engine for equi-join strategies and the queries built on them."""
