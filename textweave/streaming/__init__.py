"""Row-wise operators over streams of reports."""
