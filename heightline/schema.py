"""Explicit schemas and the type policy: u64 amounts are DECIMAL(20,0), signed deltas BIGINT, heights BIGINT."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(20, 0)
U64_MAX = 18446744073709551615
U32_MAX = 4294967295

#: Schemas are DDL text, which readers and createDataFrame take as it is; a StructType would need a session on import.
BALANCE_HISTORY = "script_hash string, block_height bigint, delta bigint, balance decimal(20,0)"
UTXO = "txid string, vout bigint, script_hash string, value decimal(20,0)"
SCRIPT_REGISTRY = "script_hash string, script_pubkey binary"
BLOCKS = "block_height bigint, block_hash string, prev_hash string, time bigint"
BLOCK_COMMITS = "block_height bigint, btc_block_hash string, balance_delta_root string, block_commit string"
PASS_HISTORY = "id bigint, inscription_id string, block_height bigint, event_type string, prev_state string, new_state string, prev_owner string, new_owner string, prev_satpoint string, new_satpoint string"
PASSES = "inscription_id string, inscription_number int, mint_txid string, mint_block_height bigint, mint_owner string, satpoint string, eth_main string, eth_collab string, prev array<string>, owner string, state string, invalid_code string, invalid_reason string"
PASS_ENERGY = "inscription_id string, block_height bigint, state string, active_block_height bigint, owner_address string, owner_balance decimal(20,0), owner_delta bigint, energy decimal(20,0)"
STATES = ("active", "dormant", "consumed", "burned", "invalid")
