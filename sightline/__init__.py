"""A PySpark engine for detection-data curation and detector evaluation."""
