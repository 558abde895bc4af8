"""Star schemas, slowly changing dimensions, upserts and mart models."""
