"""Fixed parameters of ingest, retrieval and evaluation."""

RRF_K = 60
BM25_DEPTH, DENSE_DEPTH, GRAPH_DEPTH = 100, 100, 50
BM25_K1, BM25_B = 1.2, 0.75
HOPS, FAN_OUT, HUB_DEGREE = 2, 50, 200
RERANK_DEPTH, RERANK_BATCH, TOP_K = 50, 32, 10
NEAR_DUPLICATE, SHINGLE = 0.9, 3
INGEST_SEED, PAIRS_SEED, TRAIN_SEED, BOOTSTRAP_SEED = 20260923, 20260924, 20260925, 0
TARGET_PASSAGES, TRAIN_QUESTIONS = 1000, 300
RESAMPLES, CONFIDENCE, LEAST_PAIRS = 1000, 0.95, 2
WARM_UP, P50_LIMIT, P95_LIMIT = 10, 1.2, 2.5
GRAPH_WIN_DEPTH, GRAPH_WIN_THRESHOLD = 10, 5
VALIDATION_SHARE = 0.1
CATEGORIES = ("exact-term", "paraphrase", "multi-hop-relational")
ORIGINS = ("hotpotqa", "agent-drafted")
RELEVANT_GAIN = 1
Z_95 = 1.959963984540054
EPOCHS, LEARNING_BATCH, LEARNING_RATE, WARM_STEPS, TRAIN_LENGTH, WEIGHT_DECAY, EVAL_STEPS = 3, 8, 2e-5, 100, 256, 0.01, 50
