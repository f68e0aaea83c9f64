"""Operators of a training-data pipeline: near duplicates, chat formatting, personal data, licences,
mixing, packing, media, secrets and toxicity, each as Spark jobs over whole tables."""
