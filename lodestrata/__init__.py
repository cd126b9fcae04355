"""lodestrata: analytics over software estates as DataFrame operators."""
