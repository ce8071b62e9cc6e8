"""Plan helpers shared by the operators: sessions, shared storage, ranking, join sizing."""
