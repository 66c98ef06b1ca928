"""brookmill: a Spark-native engine for multimodal series manifests, their series, texts and predictions."""
