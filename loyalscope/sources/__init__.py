"""Sources: typed scans, fixture views over the test tables, the sentiment-file adapter."""

from loyalscope.sources.layout import write_bucketed
from loyalscope.sources.readers import read_apps, read_reviews, read_sentiment_reviews, read_user_attributes
from loyalscope.sources.sentiment import adapt_sentiment_reviews

__all__ = ["read_reviews", "read_user_attributes", "read_sentiment_reviews", "read_apps", "adapt_sentiment_reviews", "write_bucketed"]
