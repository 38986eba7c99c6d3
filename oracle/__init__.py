"""DuckDB SQL oracles for the registered queries (used by the driver's check)."""
