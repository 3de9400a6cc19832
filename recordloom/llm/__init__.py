"""Operations of a training-data pipeline: packing, de-duplication, privacy, quality."""
