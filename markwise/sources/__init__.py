"""What is read and written: images, masks, features, metrics, results and settings."""
