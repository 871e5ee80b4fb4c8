"""Query plans: TPC-H Q14 and Q19, workload generators, the registry of named queries."""
