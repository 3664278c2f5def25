"""No streaming operators: what the library computes is defined over whole tables. Batch plans here read any table a stream has written."""
