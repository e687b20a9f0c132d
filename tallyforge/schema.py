"""Explicit schemas of the records that are read from files."""

GRAPH_RECORD = """
  sample_id string, path string, file_size bigint, arch string, entry bigint, label int,
  mean_entropy double, max_entropy double, min_entropy double, section_entropies array<double>,
  num_imports int, num_api_calls int, num_functions int, window_size int, vex_vocab_size int,
  structural_indicators struct<max_section_entropy: double, has_import_table_anomaly: boolean, is_likely_packed: boolean>,
  boundary_params struct<min_spread: int, max_coverage: double, far_gap: int, gap_tol: int>,
  intra_procedural_graphs map<string, struct<
    addr: bigint, name: string,
    nodes: array<struct<node_id: string, idx: int, addr: bigint, block: bigint, token: string, mnemonic: string, api: string>>,
    edges_seq: array<array<int>>, edges_cfg: array<array<int>>,
    blocks: array<struct<addr: bigint, size: int, first_idx: int, num_insns: int, jumpkind: string, vex_ids: array<int>>>,
    api_calls: array<struct<node_id: string, idx: int, api: string, position: int>>,
    seed_edges: array<struct<src_node_id: string, dst_node_id: string, src_idx: int, dst_idx: int,
                             technique_id: string, rule_name: string, confidence: string>>,
    node_indicators: array<struct<node_id: string, idx: int, technique_id: string, rule_name: string>>,
    boundary_flags: array<string>>>,
  inter_procedural_call_graph struct<edges: array<array<int>>, num_edges: int>,
  cross_function_seed_edges array<struct<src_func: string, src_node_id: string, src_idx: int,
    dst_func: string, dst_node_id: string, dst_idx: int, technique_id: string, rule_name: string, confidence: string>>
"""

MANIFEST = ("sha256 string, label int, source string, num_functions int, cluster string, split string, "
            "orig_name string, vendor string")

EVENT_LOG = "ts double, app string, bucket string, sha string, step string, reason string"

GROUPS = "sample_id string, groups array<string>, error boolean"
