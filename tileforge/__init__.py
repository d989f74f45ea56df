"""tileforge: tables transformed on Spark as many small, separately committed tiles of an ordered key."""
